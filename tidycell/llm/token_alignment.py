"""Alignment of two tokenizers by the places where tokens of both end.

Every text is encoded by a byte-level BPE (A) and by a piece BPE with byte fallback (B).  Cumulative byte
ends of each give a dictionary from end to token index; the key sets' intersection, sorted, holds the
common ends, and slices both id lists into groups.  The last A token and the last B token
of a group end together: they are its link.

Links of a corpus are counted by id pair.  Of two tokens that end together over the same bytes the shorter
one's bytes are a suffix of the longer one's, so the number of different pairs is bounded by the two
vocabularies (a token has one suffix of each length), whatever the corpus: ``pair_bound`` computes it, 324,300 for
the given ones.  Only because of this bound may the counts go to the driver and to every task; the
links themselves are written to the shared folder and never gathered.

The vocabularies are files that every executor must have; their paths are parameters.  Their special
tokens' strings in a text are ordinary text.

Defined results: B adds a space before the text, and A is given it.  A text that is null or empty, or that one of
the tokenizers does not give back byte for byte (as one with U+2581), has no tokens: zeros and an empty
groups string.  Very long texts are encoded whole; runs of white space, which are one pre-token however long they are,
go round the pattern matcher, whose stack they would exhaust.  Rows that repeat or share an id are
judged one by one; ids are passed on as they are; an empty table gives an empty result; columns other
than doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BYTE_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Fixed value: the published pre-token pattern of the byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Fixed value: the code points with the property White_Space.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LONG_SPACE = re.compile(f"[{WHITE}]{{1000,}}")
#: What every 250th character of a text with such a run must hold.
SPARSE = re.compile(f"[{WHITE}]{{4}}")


def _byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 characters for themselves,
    the other bytes in order for the characters from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """Tokenizer A: its vocabulary's merges, in order, are ranks."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        alphabet = _byte_alphabet()
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = {a + b for a, b in merges}
        ranks = {bytes(alphabet[c] for c in piece): i for piece, i in model["vocab"].items() if len(piece) == 1 or piece in made}
        order = [model["vocab"][a + b] for a, b in merges]
        if order != sorted(order):
            raise ValueError(f"{path}: ids are not in the order of the merges")
        self._encoding = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for piece, i in ranks.items():
            self.bytes[i] = piece

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        at = 0
        for m in LONG_SPACE.finditer(text) if SPARSE.search(text[::250]) else ():
            out += self._encoding.encode_ordinary(text[at : m.start()])
            at = m.end() - (m.end() < len(text))  # the last one may belong to the word behind
            out += self._encoding._encode_single_piece(text[m.start() : at])
        return out + self._encoding.encode_ordinary(text[at:])


class Pieces:
    """Tokenizer B."""

    def __init__(self, path: str):
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        piece = self._model.id_to_piece
        self.bytes = [bytes([int(piece(i)[3:5], 16)]) if self._model.is_byte(i) else piece(i).replace("▁", " ").encode() for i in range(self._model.get_piece_size())]

    def encode(self, text: str) -> list[int]:
        return self._model.encode(text, num_threads=1)


@lru_cache(maxsize=4)
def _tokenizer(kind: type, path: str):
    return kind(path)


def pair_bound(byte_path: str = BYTE_VOCABULARY, piece_path: str = PIECE_VOCABULARY) -> int:
    """How many id pairs can ever be linked."""
    a, b = (_tokenizer(kind, path).bytes for kind, path in ((ByteLevel, byte_path), (Pieces, piece_path)))
    tails = [0, 0]
    for k, (own, other) in enumerate(((a, b), (b, a))):
        ids: dict[bytes, int] = {}
        for piece in other:
            ids[piece] = ids.get(piece, 0) + 1
        tails[k] = sum(ids.get(piece[i:], 0) for piece in own for i in range(k, len(piece)))  # equal ones once
    return sum(tails)


def align(a: list[int], b: list[int], a_bytes: list[bytes], b_bytes: list[bytes]) -> Iterator[tuple[list[int], list[int]]]:
    """The groups of two encodings of the same bytes, in order."""
    i = j = 0
    for k, m in zip(*_common(np.cumsum([len(a_bytes[x]) for x in a]), np.cumsum([len(b_bytes[x]) for x in b]))):
        yield a[i:k], b[j:m]
        i, j = k, m


def _common(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[list[int], list[int]]:
    """How many tokens of each side lie before every common end."""
    a_at = dict(zip(a_ends.tolist(), range(1, len(a_ends) + 1)))
    b_at = dict(zip(b_ends.tolist(), range(1, len(b_ends) + 1)))
    common = sorted(a_at.keys() & b_at.keys())
    return list(map(a_at.__getitem__, common)), list(map(b_at.__getitem__, common))


def _digits(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of the numbers below size, from the left, and how many there are; one place is left free."""
    width = len(str(size - 1))
    text = np.array([str(i) for i in range(size)], f"S{width + 1}")
    return text.view(np.uint8).reshape(size, width + 1), np.char.str_len(text)


def _written(a: np.ndarray, b: np.ndarray, a_cut: np.ndarray, b_cut: np.ndarray, last: np.ndarray, digits: np.ndarray, length: np.ndarray) -> tuple[bytes, np.ndarray]:
    """All groups as text, and where each group's text ends; ``last`` marks a document's last groups, which no ``;`` follows."""
    ids = np.empty(len(a) + len(b), np.int64)
    a_run, b_run = np.diff(a_cut, prepend=0), np.diff(b_cut, prepend=0)
    ids[np.arange(len(a)) + np.repeat(b_cut - b_run, a_run)] = a
    ids[np.arange(len(b)) + np.repeat(a_cut, b_run)] = b
    ends = a_cut + b_cut
    mark = np.full(len(ids), ord(","), np.uint8)
    mark[ends - b_run - 1] = ord("|")
    mark[ends - 1] = ord(";")
    size = length[ids]
    shown = digits[ids]
    shown[np.arange(len(ids)), size] = mark
    size[ends[last] - 1] -= 1
    text = shown[np.arange(digits.shape[1]) <= size[:, None]]
    return text.tobytes(), np.cumsum(size + 1)[ends - 1]


def _groups(byte_path: str, piece_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = _tokenizer(ByteLevel, byte_path), _tokenizer(Pieces, piece_path)
        a_len, b_len = (np.array([len(x) for x in t.bytes]) for t in (first, second))
        width = len(second.bytes)
        digits, length = _digits(max(len(first.bytes), width))

        def one(text: str | None) -> tuple[np.ndarray, ...]:
            """Ids of both sides and the cuts, or nothing."""
            none = (np.zeros(0, np.int64),) * 4
            if not text:
                return none
            ids = second.encode(text)
            given = b" " + text.encode("utf-8", "surrogatepass")
            if b"".join(map(second.bytes.__getitem__, ids)) != given:
                return none
            a, b = np.array(first.encode(" " + text), np.int64), np.array(ids, np.int64)
            a_ends, b_ends = np.cumsum(a_len[a]), np.cumsum(b_len[b])
            if a_ends[-1] != len(given):  # a byte-level vocabulary gives the bytes back, if it has them all
                return none
            return a, b, *(np.array(c, np.int64) for c in _common(a_ends, b_ends))

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = list(zip(*map(one, part.column(1).to_pylist())))
                a, b, a_cut, b_cut = (np.concatenate(r) for r in rows)
                n_a, n_b, n = (np.array([len(x) for x in r]) for r in rows[:3])
                group_ends = np.cumsum(n)
                a_cut += np.repeat(np.cumsum(n_a) - n_a, n)
                b_cut += np.repeat(np.cumsum(n_b) - n_b, n)
                text, text_ends = _written(a, b, a_cut, b_cut, group_ends[n > 0] - 1, digits, length)
                offsets = np.concatenate([[0], text_ends])[np.concatenate([[0], group_ends])]
                said = pa.LargeStringArray.from_buffers(len(n), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(text))
                links = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], group_ends]), pa.int32()), pa.array(a[a_cut - 1] * width + b[b_cut - 1]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n_a), pa.array(n_b), pa.array(n), said.cast(pa.string()), links], names=["doc_id", "n_a", "n_b", "n_groups", "groups", "links"])

    return run


def groups(docs: DataFrame, byte_path: str = BYTE_VOCABULARY, piece_path: str = PIECE_VOCABULARY) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, groups, links): groups as ``a1,a2|b1;a3|b2,b3``; a link is a * (size of B's vocabulary) + b."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", docs["text"].cast("string").alias("text")).mapInArrow(
        _groups(byte_path, piece_path), f"doc_id {kind}, n_a long, n_b long, n_groups long, groups string, links array<long>")


def pair_counts(grouped: DataFrame, piece_path: str = PIECE_VOCABULARY) -> DataFrame:
    """(link, n, best): how many links hold each pair, and whether no pair of its B id has more."""
    width = len(_tokenizer(Pieces, piece_path).bytes)
    counts = grouped.select(F.explode("links").alias("link")).groupBy("link").agg(F.count("*").alias("n")).withColumn("b", F.col("link") % width)
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    return counts.join(most, "b").select("link", "n", (F.col("n") == F.col("most")).alias("best"))


def _scores(shared, links_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        link, n, best = shared.value
        for batch in batches:
            lists = batch.column(links_at)
            ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            at = np.searchsorted(link, lists.flatten().to_numpy(zero_copy_only=False))
            sums = [np.concatenate([[0], np.cumsum(x[at])]) for x in (best.astype(np.int64), n)]
            rest = [c for i, c in enumerate(batch.columns) if i != links_at]
            names = [x for i, x in enumerate(batch.schema.names) if i != links_at]
            yield pa.RecordBatch.from_arrays([*rest, *(pa.array(s[ends[1:]] - s[ends[:-1]]) for s in sums)], names=[*names, "n_best", "count_sum"])

    return run


def scored(grouped: DataFrame, counts: DataFrame) -> DataFrame:
    """The rows of ``groups``, written before, with n_best (links whose pair is the most frequent one of its B id) and
    count_sum (the pairs' counts) in place of the links.  The counts are at most ``pair_bound`` rows."""
    spark = grouped.sparkSession
    found = counts.select("link", "n", "best").toArrow()
    link, n, best = (found.column(i).to_numpy() for i in range(3))
    order = np.argsort(link)
    shared = spark.sparkContext.broadcast((link[order], n[order], best[order]))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in grouped.schema if f.name != "links")
    return grouped.mapInArrow(_scores(shared, grouped.columns.index("links")), f"{fields}, n_best long, count_sum long")
