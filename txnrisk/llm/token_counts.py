"""Token counts by greedy longest match, without building the pieces.

A trie over the vocabulary gets failure links as in the linear-time word-piece method: from node ``v`` with string ``s`` the
link leads to the longest continuation that is left of ``s`` once the greedy pieces at its front are cut off, and a precomputed
count says how many pieces those were. One pass over a word then adds up counts; no piece is ever made and no byte read twice.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from txnrisk.llm.text import needed, portions, texts_of

#: Distinct words whose counts one task remembers; beyond that it starts afresh.
REMEMBERED = 400_000


@dataclass(frozen=True)
class Vocabulary:
    """``starts``: pieces that may begin a word; ``inner``: pieces that may follow. ``mark`` is put before each word."""

    starts: tuple[bytes, ...]
    inner: tuple[bytes, ...]
    mark: bytes = b""


def byte_alphabet() -> dict[str, int]:
    """The printable letters that byte-level vocabulary files write for the 256 bytes."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def byte_level_vocabulary(path: str) -> Vocabulary:
    """From a tokenizer file with a byte-level vocabulary. A word is matched with one space before it, so pieces that
    begin with a space begin a word, and all others may follow; each single byte is a piece, so nothing is unknown."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)
    special = {t["content"] for t in model.get("added_tokens", [])}
    back = byte_alphabet()
    pieces = [bytes(back[c] for c in p) for p in model["model"]["vocab"] if p not in special]
    return Vocabulary(tuple(p for p in pieces if p[:1] == b" "), tuple(p for p in pieces if p[:1] != b" "), b" ")


@dataclass
class Automaton:
    """Nodes are numbers, 0 the root of words and 1 the root of continuations. ``step`` maps ``node << 8 | byte`` to a node,
    ``link`` a node to its failure node (-1: none), ``popped`` a node to the number of pieces that the link cuts off."""

    step: dict[int, int] = field(default_factory=dict)
    link: list[int] = field(default_factory=list)
    popped: list[int] = field(default_factory=list)
    mark: bytes = b""

    @classmethod
    def build(cls, vocabulary: Vocabulary) -> Automaton:
        """Breadth first over the trie, so each link is found from the links of shorter strings."""
        step: dict[int, int] = {}
        whole, size = set(), 2
        for root, pieces in ((0, vocabulary.starts), (1, vocabulary.inner)):
            for piece in pieces:
                node = root
                for byte in piece:
                    after = step.get(node << 8 | byte)
                    if after is None:
                        after = step[node << 8 | byte] = size
                        size += 1
                    node = after
                if node != root:
                    whole.add(node)
        link, popped = [-1] * size, [0] * size
        below: dict[int, list[tuple[int, int]]] = {}
        for key, after in step.items():
            below.setdefault(key >> 8, []).append((key & 255, after))
        queue = deque([0, 1])
        while queue:
            node = queue.popleft()
            for byte, after in below.get(node, ()):
                if after in whole:
                    link[after], popped[after] = 1, 1
                else:
                    back, count = link[node], popped[node]
                    while back >= 0 and back << 8 | byte not in step:
                        count += popped[back]
                        back = link[back]
                    if back >= 0:
                        link[after], popped[after] = step[back << 8 | byte], count
                queue.append(after)
        return cls(step, link, popped, vocabulary.mark)

    def count(self, word: bytes) -> int:
        """Pieces of the word; 0 if the greedy match can't cover it (an unknown word)."""
        step, link, popped = self.step, self.link, self.popped
        node = pieces = 0
        for byte in self.mark + word:
            after = step.get(node << 8 | byte)
            while after is None:
                pieces += popped[node]
                node = link[node]
                if node < 0:
                    return 0
                after = step.get(node << 8 | byte)
            node = after
        while node != 1:
            pieces += popped[node]
            node = link[node]
            if node < 0:
                return 0
        return pieces


class Remembered(dict):
    """Counts of words already seen in this task, bounded."""

    def __init__(self, automaton: Automaton):
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        count = self[word] = self.automaton.count(word)
        return count


RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_tokens", pa.int64()), ("n_unknown", pa.int64())])


def token_counts(docs: DataFrame, vocabulary: Vocabulary, lower: bool = False) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_words, n_tokens and n_unknown.

    A word that no sequence of pieces covers greedily is one unknown token. A null, empty or blank text has 0 of everything;
    a null doc_id stays null; repeated rows give repeated results; other columns are not read. One map over the whole texts,
    no shuffle; the automaton travels with the task (its size is the vocabulary's, whatever the input).
    """
    held = docs.sparkSession.sparkContext.broadcast(Automaton.build(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        counts = Remembered(held.value)
        for batch in portions(batches):
            words, tokens, unknown = [], [], []
            for text in texts_of(batch):
                got = [counts[w] for w in (text.lower() if lower else text).split()]
                missed = got.count(0)
                words.append(len(got))
                unknown.append(missed)
                tokens.append(sum(got) + missed)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(words, pa.int64()), pa.array(tokens, pa.int64()), pa.array(unknown, pa.int64())], schema=RESULT)

    return needed(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_tokens long, n_unknown long")
