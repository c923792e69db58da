"""Token counts that are kept up under edits.

A document is cut into leaves of some hundred characters, only where no pre-token
can span the cut: before a space or line end that follows a character that is no white
space.  Each leaf is encoded by itself, and a segment tree over the leaves holds
the sums.  An edit touches the leaves it overlaps and, as the context that decides
where pre-tokens end, any leaf it borders on; leaves that become small take their neighbour along.  Only these
are encoded again and cut anew.  Where their number stays, their counts and the sums on the
paths to the root are updated; where leaves split or merge, the sums above the known counts are added up
anew, without encoding anything.  The root is the count of the edited document, and the tree takes the next edits.

The vocabulary is a file of byte-pair ranks that every executor must have; its path is a parameter.  Special
tokens' strings are ordinary text.

Defined results: a null text counts as empty and has 0 tokens; edits are given by character
positions, in order and apart; very long texts are counted whole, also where they hold no place to cut: a long run of
white space, which is one pre-token, goes round the pattern matcher, whose stack it would exhaust; rows are counted
one by one, repeated or not; an empty table gives an empty result; extra columns stay, but for the four names
__tokens, __edits, __tokens_after and __again, which a table must not have.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidycell.llm.token_alignment import LONG_SPACE, SPARSE

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the published pre-token pattern of this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEAF_CHARS = 512
Edit = tuple[int, int, str]


@lru_cache(maxsize=4)
def encoding(path: str = VOCABULARY):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


_SPACE = re.compile(r"[ \n]")


def cuts(text: str, size: int = LEAF_CHARS) -> list[int]:
    """Ends of the leaves: places that no pre-token spans, the first such after every ``size`` characters."""
    ends, at = [], 0
    while at + size < len(text):
        m = _SPACE.search(text, at + size)
        while m and (text[m.start() - 1].isspace() or text[m.start() - 1] in "\x1c\x1d\x1e\x1f"):
            m = _SPACE.search(text, m.end())
        if not m:
            break
        at = m.start()
        ends.append(at)
    ends.append(len(text))
    return ends


def encoder(path: str = VOCABULARY) -> Callable[[str], list[int]]:
    """A function that encodes any text whole."""
    model = encoding(path)

    def encode(text: str) -> list[int]:
        if len(text) < 1000 or not SPARSE.search(text[::250]):
            return model.encode_ordinary(text)
        out, at = [], 0
        for m in LONG_SPACE.finditer(text):
            out += model.encode_ordinary(text[at : m.start()])
            at = m.end() - (m.end() < len(text))  # the last one may belong to the word behind
            out += model._encode_single_piece(text[m.start() : at])
        return out + model.encode_ordinary(text[at:])

    return encode


class Tree:
    """A document's leaves and the sums over them."""

    def __init__(self, text: str, encode: Callable[[str], list[int]]):
        self.text, self.encode = text, encode
        ends = cuts(text)
        self._build(ends, [len(encode(text[a:b])) for a, b in zip([0, *ends[:-1]], ends)])

    def _build(self, ends: list[int], counts: list[int]) -> None:
        """Leaves with known counts, and the sums above them."""
        self.ends = np.array(ends, np.int64)
        self.starts = np.concatenate([[0], self.ends[:-1]])
        n = len(ends)
        self.width = 1 << max(0, (n - 1).bit_length())
        self.sums = np.zeros(2 * self.width, np.int64)
        self.sums[self.width : self.width + n] = counts
        level = self.width
        while level > 1:
            self.sums[level // 2 : level] = self.sums[level : 2 * level].reshape(-1, 2).sum(1)
            level //= 2

    @property
    def total(self) -> int:
        return int(self.sums[1])

    def _set(self, leaf: int, count: int) -> None:
        i = self.width + leaf
        change = count - self.sums[i]
        while change and i:
            self.sums[i] += change
            i //= 2

    def apply(self, edits: list[Edit]) -> tuple[str, int]:
        """Carry out edits, given in order and apart; the new text and how many characters were encoded again."""
        text, done, again, k = [], 0, 0, 0
        touched: list[tuple[int, int, list[int], list[int]]] = []  # first and last leaf, lengths and counts of the new ones
        while k < len(edits):
            # Leaves that the edit overlaps or borders on, and then the edits in or beside those.
            first = last = int(np.searchsorted(self.ends, edits[k][0]))
            part, size = [], 0
            begin = at = int(self.starts[first])
            while True:
                while k < len(edits) and edits[k][0] <= self.ends[last]:
                    a, b, new = edits[k]
                    part += [self.text[at:a], new]
                    size += a - at + len(new)
                    at = b
                    last = max(last, int(np.searchsorted(self.starts, b, "right")) - 1)
                    k += 1
                end = int(self.ends[last])
                if size + end - at >= LEAF_CHARS // 2 or last + 1 == len(self.ends):
                    break
                last += 1
            part.append(self.text[at:end])
            fresh = "".join(part)
            text += [self.text[done:begin], fresh]
            done = end
            again += len(fresh)
            ends = cuts(fresh)
            pieces = list(zip([0, *ends[:-1]], ends))
            touched.append((first, last, [b - a for a, b in pieces], [len(self.encode(fresh[a:b])) for a, b in pieces]))
        text.append(self.text[done:])
        self.text = "".join(text)
        sizes = self.ends - self.starts
        if all(last - first + 1 == len(counts) for first, last, _, counts in touched):
            for first, last, lengths, counts in touched:
                sizes[first : last + 1] = lengths
                for leaf, count in enumerate(counts, first):
                    self._set(leaf, count)
            self.ends = np.cumsum(sizes)
            self.starts = self.ends - sizes
        else:
            known = self.sums[self.width : self.width + len(sizes)]
            new_sizes, new_counts, leaf = [], [], 0
            for first, last, lengths, counts in touched:
                new_sizes += [sizes[leaf:first], np.array(lengths, np.int64)]
                new_counts += [known[leaf:first], np.array(counts, np.int64)]
                leaf = last + 1
            counts = np.concatenate([*new_counts, known[leaf:]])
            ends = np.cumsum(np.concatenate([*new_sizes, sizes[leaf:]]))
            full = np.diff(ends, prepend=0) > 0  # an emptied leaf at the end goes, unless it is the only one
            if full.any() and not full.all():
                counts, ends = counts[full], ends[full]
            self._build(ends.tolist(), counts.tolist())
        return self.text, again


_MAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")


def cleanup(text: str) -> list[Edit]:
    """The edits of a usual clean-up: lines that repeat an earlier one go with their line end, and mail
    addresses become ``<email>``."""
    edits: list[Edit] = []
    seen: set[str] = set()
    at = 0
    for line in text.split("\n"):
        end = at + len(line)
        if line.strip() and line in seen:
            edits.append((at - 1, end, ""))  # a repeat has a line before it
        else:
            seen.add(line)
            if "@" in line:
                edits += [(at + m.start(), at + m.end(), "<email>") for m in _MAIL.finditer(line)]
        at = end + 1
    return edits


def _run(edits_of: Callable[[str], list[Edit]], path: str, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            rows: list[tuple] = []
            for text in batch.column(text_at).to_pylist():
                tree = Tree(text or "", encode)
                before = tree.total
                edits = edits_of(tree.text)
                again = tree.apply(edits)[1] if edits else 0
                rows.append((before, len(edits), tree.total, again))
            out = [pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], names=[*batch.schema.names, "__tokens", "__edits", "__tokens_after", "__again"])

    return run


def count(docs: DataFrame, edits_of: Callable[[str], list[Edit]] = cleanup, path: str = VOCABULARY) -> DataFrame:
    """``docs`` with __tokens, __edits, __tokens_after (of the edited text) and __again (characters
    that the edits made to be encoded again)."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(_run(edits_of, path, docs.columns.index("text")), f"{fields}, __tokens long, __edits long, __tokens_after long, __again long")
