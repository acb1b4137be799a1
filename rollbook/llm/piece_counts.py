"""Token counts by a linear longest-match automaton.

A word's pieces are the longest vocabulary entries that match from the left, one
after another. The entries make a trie. For every node the failure link leads to the
node of what remains when the pieces of the node's string are taken off, and the
number of pieces taken off is precomputed; so one pass over the bytes of a word
gives its number of pieces, without building any.

Words are those of the byte-level split pattern; the vocabulary is that of a public
tokenizer.json as byte strings. A byte that the vocabulary lacks is a piece of its own.

Results for odd rows: null and empty texts have no words and no pieces; repeated rows
give repeated results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.llm.bpe import CACHED_WORDS, split_patterns, vocabulary
from rollbook.llm.common import in_batches, per_process, text_of


class Automaton:
    """Trie with failure links and numbers of popped pieces; node 0 is the root."""

    def __init__(self, entries: Iterable[bytes]):
        self.child: list[dict[int, int]] = [{}]
        final = [False]
        for entry in [*entries, *(bytes([b]) for b in range(256))]:
            node = 0
            for byte in entry:
                after = self.child[node].get(byte)
                if after is None:
                    after = self.child[node][byte] = len(self.child)
                    self.child.append({})
                    final.append(False)
                node = after
            final[node] = bool(node)
        self.fail, self.popped = [0] * len(final), [0] * len(final)
        queue = deque([0])
        while queue:
            parent = queue.popleft()
            for byte, node in self.child[parent].items():
                queue.append(node)
                if final[node]:
                    self.popped[node] = 1
                    continue
                at, taken = self.fail[parent], self.popped[parent]
                while byte not in self.child[at]:  # ends at the root, which has every byte
                    taken += self.popped[at]
                    at = self.fail[at]
                self.fail[node], self.popped[node] = self.child[at][byte], taken

    def count(self, word: bytes) -> int:
        """How many pieces a word has."""
        child, fail, popped = self.child, self.fail, self.popped
        node = pieces = 0
        for byte in word:
            while (after := child[node].get(byte)) is None:
                pieces += popped[node]
                node = fail[node]
            node = after
        while node:
            pieces += popped[node]
            node = fail[node]
        return pieces


class _Counts(dict):
    """Word -> its number of pieces; starts anew when full."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        n = self[word] = self.automaton.count(word.encode())
        return n


def count_pieces(docs: DataFrame, content: bytes) -> DataFrame:
    """doc_id, n_words and n_tokens of each text. ``content`` is the text of a tokenizer.json. No shuffle."""
    shipped = docs.sparkSession.sparkContext.broadcast(content)
    key = f"pieces-{hashlib.sha256(content).hexdigest()}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = per_process(key, lambda: _Counts(Automaton(vocabulary(shipped.value)[0])))
        split = per_process("split-patterns", split_patterns)
        for batch in batches:
            words, tokens = [], []
            for text in batch.column(1).to_pylist():
                found = split(text)
                words.append(len(found))
                tokens.append(sum(map(counts.__getitem__, found)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())],
                names=["doc_id", "n_words", "n_tokens"],
            )

    own = docs.select(F.col("doc_id").cast("long"), text_of().alias("text"))
    return own.transform(in_batches, run, "doc_id long, n_words long, n_tokens long")
